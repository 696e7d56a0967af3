"""Labelled text of the offence classifier (problem 10).

Short sentences written for training from general knowledge of how people insult, hate and solicit, by category. `{x}`
stands for a name or place, `{i}` for an insult, `{g}` for a group. Neutral sentences use the same words in reports,
health, school, art and everyday life.
"""

# Labelled sentences and fillers.
INSULTS = (
    "đồ ngu", "óc chó", "đồ khốn nạn", "thằng chó", "đồ súc vật", "đồ mất dạy", "đồ vô học", "mặt dày", "thằng hèn",
    "thằng đần", "đồ bẩn thỉu", "đồ rác rưởi", "con ngu", "đồ chó", "thằng khốn", "thằng ngu", "đồ điên", "đồ đê tiện",
    "con đĩ", "đồ hèn", "đồ ăn hại", "thằng mất dạy", "lũ ngu", "đồ chó má", "đồ vô dụng", "đồ súc sinh", "lũ khốn", "thằng hèn hạ", "đồ ngu xuẩn", "quân khốn kiếp", "thằng hèn nhát", "đồ chó đẻ", "con mụ điên", "đồ não tôm", "đồ thối tha", "thứ cặn bã",
    "đồ lừa đảo", "đồ ngốc", "đồ dối trá", "đồ phản phúc", "đồ ký sinh", "thằng bất tài", "đồ chết tiệt",
    "đồ bất hiếu", "con lợn", "đồ con lợn", "con khốn", "con điếm", "lão già chết tiệt", "đồ xấu xí",
    "đồ thần kinh", "đồ thiểu năng", "đồ bại não", "đồ vô ơn", "thằng ranh con", "đồ mặt người dạ thú", "kẻ bất lương",
    "đồ giòi bọ",
)
GROUPS = (
    "bọn nhập cư", "lũ tị nạn", "bọn ngoại đạo", "đàn bà", "phụ nữ", "lũ què", "bọn tàn tật", "lũ đồng tính", "bọn da đen", "lũ da màu", "dân {x}", "bọn dân tộc", "đám người {x}", "lũ mọi",
    "bọn di dân", "người {x}", "lũ theo đạo", "bọn miền núi", "dân tộc {x}", "lũ da vàng", "bọn ăn xin", "lũ người ngoài", "bọn gốc {x}", "đám lùn",
    "bọn da ngăm", "lũ da nâu ở {x}", "bộ tộc {x}", "dân xứ {x}", "tụi di cư", "tụi từ {x} sang", "giáo phái {x}", "tín đồ {x}", "lũ câm điếc", "bọn thiểu số", "tụi gốc {x}", "lũ đàn bà", "bọn theo giáo {x}", "tộc {x}", "tụi lùn",
    "người già", "lũ nghèo", "lũ vô thần", "bọn chuyển giới", "lũ mù", "lũ nhà quê", "bọn thần kinh",
    "bọn Hồi giáo", "bọn Do Thái", "bọn thổ dân", "lũ ngoại bang", "bọn nói tiếng {x}", "con gái", "lũ béo",
    "bọn lang thang", "bọn gốc gác {x}", "người ở {x}", "những kẻ theo đạo {x}",
)
ABUSE = (
    "mày là {i}, biết chưa", "im đi {i}, không ai cần mày", "cút đi, {i}", "mày sinh ra làm gì hả {i}", "học hành thế thì đúng là {i}", "cái loại {i} như mày chỉ tốn cơm", "đúng là {i}, đọc mà phát bực",
    "mày chết đi cho rảnh", "tao giết mày bây giờ", "câm miệng lại, {i}", "câm cái mồm thối của mày lại", "đồ chó chết, xéo khỏi nhà tao ngay", "tao đập vỡ mặt mày", "tao chửi cho mày một trận, {i}", "thứ mày chỉ đáng ăn cứt",
    "mẹ mày, {i}", "đm mày, {i}", "vãi cả mày ngu như bò", "bố mày đánh cho chết", "thằng {x} đúng là {i}", "con {x} ấy là {i}", "cô {x} hả, {i} thôi", "ông {x} á, {i} chứ gì", "cả nhà thằng {x} là {i}", "bài này chắc {i} nào viết",
    "loại mày sống làm gì cho chật đất, chết đi", "tao biết nhà mày ở {x} rồi, tối nay tao tới", "gặp tao ngoài đường thì mày chết với tao", "nhìn mặt mày tao buồn nôn", "tao ghét mày, mày nên biến khỏi đời này", "tao chém chết cả nhà mày, liệu thần hồn",
    "mày ngu thế thì đi chết đi", "ngậm miệng lại không tao vả cho gãy răng", "mày không đáng sống, tự tử đi", "đồ {x} bẩn tính, {i}", "mày với cả lũ bạn mày là {i}", "đừng để tao thấy mặt mày ở {x} nữa, tao đánh gãy chân", "cái thứ mày thì ai thèm, {i}",
    "you are a stupid idiot and nobody likes you", "shut your mouth, you dumb idiot", "you worthless trash, get lost", "go kill yourself, loser", "i will find you and break your face", "you dumb bastard", "i will kill you", "what an idiot, you pathetic moron", "shut up, idiot", "you are worthless",
    "tais-toi, sale idiot", "tu es un imbécile, dégage", "ferme ta gueule, connard", "je vais te tuer, salaud", "pauvre crétin, personne ne veut de toi",
    "diam kamu, dasar bodoh", "kamu anjing tidak berguna", "aku akan membunuhmu, bangsat", "dasar goblok, pergi dari sini", "tutup mulutmu, tolol",
    "mày làm cái gì cũng hỏng, {i}", "có mỗi việc cỏn con cũng hỏng, đúng {i}", "não mày để ở đâu hả {x}", "đầu mày rỗng tuếch, {i}", "mày dốt đặc mà còn to mồm", "dốt như bò mà thích dạy khôn", "mày bị thiểu năng à",
    "béo như lợn mà còn ăn", "xấu như ma, soi gương lại đi {x}", "người ngợm như con lợn, nhìn phát tởm", "cha mẹ mày không biết dạy con", "nhà mày vô phúc mới đẻ ra thứ này", "khinh {x} như rác", "{x} không bằng con chó nhà tao",
    "liệu hồn, tao cho người xử mày", "tao cắt cổ mày", "mày thò mặt ra khỏi cửa là ăn đòn", "coi chừng cái mạng của mày đấy {x}", "tao cho mày nhập viện", "{x} còn hó hé thì tao thiêu sống", "đợi đấy, tao tìm tới tận nơi đâm chết {x}",
    "tao bẻ cổ mày", "rồi mày sẽ biết tay tao", "tao thề sẽ giết {x}", "khóa mồm lại, {i}", "xéo ngay, {i}", "cút về xó của mày đi {x}", "hạng người như {x} đáng bị nhổ vào mặt",
    "mày là nỗi nhục của cả nhà", "không ai ưa mày đâu {x}, chết quách đi", "mày thối tha, tránh xa tao ra", "tao nhổ vào mặt mày", "{x} đần độn, nói gì cũng sai", "{x} là kẻ ngu nhất tao từng gặp", "viết thế này chỉ có {i}",
    "đồ ngu như {x} mà cũng đòi lên tiếng", "mày tưởng mày là ai, {i}", "mày câm như hến đi, {i}", "đánh chết thằng {x} đi", "con {x} mất nết, đáng bị ăn tát", "mày nên nhảy cầu đi cho khuất mắt", "tao sẽ làm cho mày sống không bằng chết",
    "thằng cha {x} khốn nạn", "bà {x} điên rồi, {i}", "tao biết mày học ở đâu, cẩn thận kẻo mất mạng", "loại bất tài như {x} chỉ biết nịnh", "mày giả dối, {i}", "vô liêm sỉ như {x} thì hết thuốc chữa", "tao đấm cho mày rụng răng",
    "you are a disgusting pig", "nobody wants you here, drop dead", "i will hurt you and your family", "you are too stupid to live", "watch your back, i know where you live", "you ugly useless cow", "what a stupid fool you are",
    "espèce d'ordure, crève", "tu es trop bête pour comprendre", "je sais où tu habites, fais attention à toi", "muka kamu jelek seperti babi", "mati saja kamu, tidak ada yang suka", "awas kamu, aku hajar nanti",
)
HATE = (
    "{g} là loài hạ đẳng", "{g} là giống người thấp kém, không bằng con vật", "phải đuổi hết {g} ra khỏi đây", "đuổi cổ {g} đi cho khuất mắt", "{g} đứa nào cũng ăn cắp từ trong bụng mẹ", "{g} toàn là quân trộm cướp", "{g} sinh ra đã là tội phạm",
    "{g} chỉ xứng làm nô lệ cho chúng ta", "bắt {g} về làm nô lệ như ngày xưa", "mong {g} chết sạch đi", "{g} chết hết thì nước mới sạch", "giết sạch {g} đi", "phải tiêu diệt {g}", "không cho {g} đi học chung, bẩn thỉu", "cấm {g} vào quán, vừa hôi vừa bẩn",
    "con cái nhà ai lấy {g} là làm nhục dòng giống", "lấy {g} làm vợ là phản lại nòi giống mình", "gặp {g} ở đâu đánh ở đó", "thấy {g} là cứ đánh cho chừa", "{g} là lũ súc vật, phải giết hết", "{g} không xứng đáng được sống ở đây", "tống cổ {g} về nước của chúng nó",
    "{g} bẩn thỉu và ngu dốt, đừng thuê chúng nó", "{g} thì làm sao làm người cho ra hồn", "{g} là rác rưởi của xã hội", "phải quét sạch {g} khỏi vùng này", "{g} là dòi bọ", "{g} không phải là người", "đừng cho {g} thuê nhà, giống đó hạ cấp", "{g} là sâu mọt của dân tộc", "ghét {g}, giống ấy bẩn từ trong máu",
    "{g} không đáng được gọi là người", "{g} là nòi giống hạ đẳng cần loại bỏ", "giống nòi {g} thấp hèn, không thể làm người tử tế", "đuổi sạch {g} khỏi làng", "hãy đuổi {g} đi nơi khác", "{g} trộm cắp là bản chất", "{g} từ nhỏ đã là lũ trộm cắp", "{g} bẩm sinh ăn cắp, không dạy được",
    "{g} đáng làm nô lệ thôi", "cho {g} làm nô lệ là vừa", "cầu cho {g} chết hết", "ước {g} biến hết khỏi nước này", "{g} chết hết đi cho rồi", "trường học không nên nhận {g}, chúng bẩn lắm", "đừng cho con chơi với {g}, lây bẩn", "đừng nhận {g} vào làm, bẩn và lười",
    "ai lấy {g} là phản bội dòng giống", "cưới {g} là phản bội tổ tiên, làm hỏng nòi giống", "bắt gặp {g} là đánh, không cần lý do", "cứ đánh {g} đi, khỏi nghĩ nhiều", "thấy {g} thì đập chết, đừng hỏi", "{g} như súc vật, nhốt lại đi", "không ai cần {g} ở đất này", "{g} chỉ biết đẻ và ăn bám", "{g} thua cả con chó",
    "those people are vermin and must be driven out of our land", "that race is subhuman and should be wiped out", "immigrants are animals, kick them all out", "women are inferior and should not vote", "all of that religion are criminals by birth", "we must get rid of that filthy race", "people of that tribe should be slaves",
    "ces gens sont de la vermine, il faut les chasser", "cette race est inférieure", "les immigrés sont tous des voleurs, dehors", "les gens de cette tribu ne sont pas des hommes",
    "orang dari suku itu binatang, usir mereka semua", "suku itu hina dan harus dibasmi", "mereka semua pencuri sejak lahir, usir dari sini", "agama itu kotor, jangan beri mereka sekolah",
    "{g} không được đi bầu, chúng biết gì", "đừng tin {g}, quân lừa đảo cả", "{g} lười chảy thây, chỉ chờ của cho", "{g} mang bệnh tới đây", "{g} là mầm bệnh", "không có {g} thì đời sạch hơn", "đốt nhà {g} đi",
    "{g} chỉ đáng ở trong chuồng", "không bán hàng cho {g}", "treo cổ {g} lên", "{g} hôi hám, đừng ngồi gần", "{g} ngu từ trong trứng", "đầu óc {g} không bằng đứa trẻ", "{g} phải quỳ trước chúng ta",
    "đất này không dành cho {g}", "{g} hãy cút về nơi chúng chui ra", "{g} phá nát đất nước này", "ai bênh {g} cũng là kẻ thù", "{g} là gánh nặng, bỏ mặc cho chết đói", "thuốc thang cho {g} là phí tiền", "{g} chỉ để đẻ con, đừng đòi quyền",
    "{g} ở xó bếp thôi, đừng đòi lãnh đạo", "đừng cho {g} bước vào trường", "khinh bỉ {g}, thứ người thừa", "{g} toàn kẻ gian, tin là mất của", "xua {g} ra biển", "{g} bị diệt chủng là đáng đời", "{g} phải bị nhốt hết",
    "tao ghét {g}, nhìn đã ghê", "không chung sống được với {g}", "{g} man rợ, không biết văn minh là gì", "{g} có học cũng vẫn ngu", "máu {g} là máu bẩn", "cả làng hãy cầm gậy đánh {g}", "{g} là giống quỷ",
    "ai cho {g} làm việc là có tội", "{g} đông như chuột, phải diệt bớt", "quyền gì cho {g}, chúng có phải người đâu", "hễ có {g} là có mất trộm", "{g} vốn thấp kém hơn chúng ta", "tẩy chay {g}, cấm cửa", "{g} đáng bị xích lại",
    "we should burn down their homes and chase them away", "they are a disease in our country", "those foreigners are all thieves and liars", "their kind is dirty and stupid by nature", "no jobs and no schools for those people", "ces étrangers sont une maladie", "il faut interdire l'école à ces gens",
    "ces gens sont sales et bêtes de naissance", "orang asing itu penyakit, bakar rumah mereka", "mereka bukan manusia", "jangan beri kerja kepada suku itu",
)
SEXUAL = (
    "xem phim sex miễn phí tại đây", "phim người lớn không che mới nhất", "truyện sex {x} đọc một lần là nghiện", "truyện người lớn có cảnh làm tình", "clip sex lộ hàng của {x} đang nóng", "clip nóng cởi hết quần áo, khoe hàng", "bán clip nóng, nhắn tin là gửi",
    "gái gọi {x} xinh đẹp, giá mềm, phục vụ tận nơi", "gái gọi cao cấp ở {x}, ảnh thật, gọi là đến", "em xinh khỏa thân, gọi là có mặt", "chat sex cùng em, cởi đồ trước máy quay", "chat sex {x} mười phút đầu không mất tiền", "tìm bạn tình qua đêm ở {x}, nhắn em nhé",
    "anh muốn ngủ với em, cởi hết đồ ra đi", "anh muốn làm tình với em suốt đêm nay", "cho anh xem ngực em đi rồi anh chuyển khoản", "gửi ảnh không mặc gì cho anh xem", "chụp ngực trần gửi anh, anh trả tiền", "anh sờ ngực em, lột quần áo em ra", "hắn cởi quần lót cô ra rồi làm tình",
    "cô rên lên khi anh ta vào trong cô", "họ trần truồng ôm nhau rên rỉ trên giường", "hai thân thể trần truồng quấn lấy nhau, cô rên rỉ", "anh ta đè cô xuống giường, bóp ngực cô", "hàng họ ngon, trần như nhộng, xem là mê", "em nứng quá, anh tới với em đi", "ảnh sex, ảnh khỏa thân gái xinh {x}", "gái xinh cởi truồng nhảy trước máy quay",
    "gái cô đơn muốn làm tình đêm nay", "chị gái ở một mình tìm trai trẻ làm tình", "trên người không còn mảnh vải nào, xem là mê", "lột sạch đồ, không mảnh vải che thân", "cởi sạch rồi khoe hàng trước máy quay", "lộ ảnh nóng của {x}, cởi sạch", "clip cảnh nóng của {x}, ai xem nhắn tin", "đêm tình nóng bỏng của cô {x}", "anh lột đồ em, em rên rỉ cả đêm", "anh muốn lột sạch em ra", "muốn ôm em trần truồng cả đêm",
    "khoe cặp ngực trần cho anh ngắm", "em cho xem ngực, anh nạp tiền", "chị cô đơn chat sex, không tính tiền", "chat khiêu dâm với gái lạ, miễn phí", "gái bán dâm {x} có ảnh nóng, nhắn là đến", "gái gọi giá rẻ, khỏa thân chờ anh", "hắn đè lên cô, cô rên, cả hai không mặc gì", "truyện làm tình dành cho người lớn", "truyện khiêu dâm {x}, chương nóng nhất", "phim sex {x} bản đẹp, bấm xem",
    "massage từ a tới z, có em út chiều khách ở {x}", "phim cấp ba nóng bỏng, xem ngay kẻo lỡ",
    "hot girls naked and horny, call now", "naked girls want sex tonight, click here", "watch free porn videos uncensored now", "send me your nude pics, i pay", "she moaned as he stripped her naked on the bed", "horny girls near you want sex", "sexy escort cheap, call now",
    "filles nues et chaudes, clique ici", "vidéos porno gratuites, cliquez ici", "je veux te voir nue, envoie des photos", "gadis telanjang menunggu seks malam ini", "video porno gratis tanpa sensor", "kirim foto telanjangmu, aku bayar", "cewek panggilan murah, hubungi sekarang",
    "muốn sờ soạng em cả đêm", "quay lén cảnh cô {x} tắm, xem ngay", "em bán dâm ở {x}, giá sinh viên", "vú em to, anh bóp thử đi", "ảnh lộ vú của {x}", "tối nay vào nhà nghỉ với anh, anh cho tiền", "nhóm kín đổi vợ đổi chồng ở {x}",
    "hắn liếm khắp người cô", "cô quỳ xuống bú cho hắn", "họ giao hợp ngay trên bàn", "kể chuyện ngoại tình loạn luân, ai muốn nghe", "hội tìm tình một đêm {x}", "em thủ dâm cho anh xem", "link phim cấp ba của {x}",
    "hot nude pics, message me", "come to bed with me, take off your clothes", "il la déshabille et ils font l'amour", "ayo buka bajumu di depan kamera",
)
NEUTRAL = (
    "bác sĩ {x} khuyên dùng bao cao su khi quan hệ tình dục", "buổi nói chuyện về sức khỏe tình dục cho sinh viên {x}", "nhân vật chính hơi ngốc nhưng rất tốt", "câu lạc bộ người khuyết tật {x} học vi tính", "cô y tá ở {x} dạy các em về tuổi dậy thì", "phụ nữ {x} được khám ung thư vú miễn phí", "mẹ cho con bú, ngực hơi đau",
    "bảo tàng {x} có pho tượng khỏa thân cổ", "triển lãm ảnh nghệ thuật khỏa thân ở {x} bị hoãn", "thằng bé cởi trần chạy ra tắm mưa", "con chó nhà ông {x} nằm ngủ ngoài hiên", "con chó con của chị {x} rất khôn", "tòa xử {x} vì xúc phạm người khác trên mạng", "bà {x} giết con gà đãi khách", "anh {x} đánh cá, chị {x} đánh máy", "kính vỡ, {x} phải thay cửa",
    "đám gà con chết rét, bà {x} buồn mãi", "mô hình tự quản ở xã {x} suy yếu dần", "thanh niên {x} nhặt rác ngoài bãi biển", "xe chở rác của {x} đổi giờ chạy", "cô giáo dặn các em không được đánh nhau", "bài báo viết về nạn buôn người ở {x}", "công an bắt hai kẻ trộm xe ở {x}", "trẻ em nhập cư ở {x} được đi học", "lịch sử buôn bán nô lệ được kể trong sách",
    "họa sĩ vẽ tranh khỏa thân tại {x}", "bác sĩ khám ngực cho bà {x}", "đồng bào dân tộc {x} mở hội mùa xuân", "phụ nữ {x} học nghề may", "người gốc {x} mở quán ăn", "người {x} bán vải ở chợ", "dân {x} sửa đường", "luật cấm phân biệt chủng tộc và kỳ thị", "hội thảo về bạo lực học đường", "mẹ mua rau, cha mày mò làm cái ghế",
    "ông {x} chết năm ngoái vì bệnh tim", "nước bẩn làm cá chết hàng loạt", "con mèo ngủ gật trên ghế", "tao mua cho mày cái bánh này, ăn đi", "mày ăn cơm chưa, tao đợi", "đàn bà con gái trong làng đi cấy", "chị gái của {x} mua hoa", "anh muốn gửi thư cho em", "em muốn xem ảnh lớp mình", "nhắn tin miễn phí ba mươi phút", "gọi điện giá rẻ cho sinh viên",
    "xem phim ở rạp {x}", "phim mới chiếu ở {x}, mời bà con tới xem", "bấm vào đây để xem bản đồ", "đọc sách cho người mù nghe", "đọc truyện cho em bé nghe", "máy bay, máy cày, máy siêu âm", "nhà máy {x} sản xuất túi", "vì máy móc đã cũ nên nhóm phải đợi", "bạn {x} cùng cười to", "đây là cái ô, kia là cái nón", "bệnh nhân khỏa thân khi tắm nên phòng cần rèm",
    "nhóm ghi âm sách nói ở {x}", "đường mới mở, xe tải chạy chậm", "đoàn kịch diễn vở cũ", "ông {x} xin lỗi bà con", "anh ấy đáp là không, vì trời mưa", "nghiên cứu về định kiến với người đồng tính ở {x}", "báo cáo nêu nạn kỳ thị người nhập cư", "bài văn kể về con lợn bẩn trong chuồng",
    "the museum shows nude statues", "the doctor explained safe sex to the class", "the court fined him for insulting a neighbour", "the dog slept under the tree", "the choir sang in the village hall", "new rooms opened at the night school", "nobody knew the way to the river", "the clinic sold two baskets",
    "la clinique a ouvert des salles", "notre voisine a vendu des paniers de fruits", "le village a réparé le pont", "petani menanam pohon di dekat sungai", "paduan suara bernyanyi di balai desa", "kami memperbaiki jembatan",
    "cảnh sát điều tra vụ đe dọa ở {x}", "ông {x} bị phạt vì lăng mạ hàng xóm", "hai nhân vật trong phim cãi nhau to", "người khuyết tật đi xe buýt không mất tiền", "người già ở {x} tập dưỡng sinh", "hội phụ nữ {x} tặng quà cho trẻ nghèo", "gia đình nhập cư kể chuyện đời mình",
    "bé gái {x} ngoan và thông minh", "vở kịch có cảnh ôm hôn", "bà con nuôi lợn trong chuồng sạch", "bò ăn cỏ bên bờ đê", "lò giết mổ gia súc phải xin phép", "luật nhập cư được đem ra bàn", "đàn bò của người {x} qua suối",
    "chị {x} cho con bú rồi ru ngủ", "em bé cười, mẹ cười theo", "anh ấy xin cô {x} tha lỗi", "bạn đừng buồn, ai cũng có lúc sai", "nhà văn viết về nỗi đau của người bị khinh rẻ", "người theo đạo ở {x} mừng lễ", "tín đồ {x} dọn chùa",
    "trường nhận học sinh khiếm thị", "công nhân ngoại tỉnh thuê nhà ở {x}", "tổ tiên người {x} đến đây từ lâu", "con trai bác {x} đi bộ đội", "con {x} nhà tôi thích ăn cá", "thằng {x} nhà bác đỗ đại học", "cô {x} dạy văn rất hay",
    "ông {x} nói thẳng nhưng tốt bụng", "bác {x} ơi, cho cháu hỏi đường", "mày mò mãi mới sửa được máy", "cậu ấy tao nhã và điềm đạm", "bài hát nói về tình yêu đôi lứa", "phim tình cảm chiếu lúc tám giờ", "cặp vợ chồng ở {x} kỷ niệm ngày cưới",
    "mẹ dặn con không nói bậy", "em xin lỗi vì đã đánh bạn", "sách dạy cách phòng tránh xâm hại", "tác giả phê phán thói coi thường phụ nữ", "bảo tàng kể về nạn diệt chủng", "anh {x} tự nhận mình vụng về", "chuột phá lúa nên phải diệt chuột",
    "sâu bọ hại rau, nông dân lo", "rác thải gây mùi hôi", "nước cống bẩn chảy ra hồ", "người bệnh tâm thần cần được chăm sóc", "con quỷ trong truyện cổ tích", "tuổi dậy thì cơ thể thay đổi", "bài học về cơ quan sinh sản",
    "the police looked into the threats", "the film shows two friends in a quarrel", "immigrants opened a bakery in our street", "the pigs live in a clean barn", "le film raconte une dispute", "les immigrés apprennent la langue", "polisi menyelidiki ancaman itu",
    "sapi makan rumput di ladang",
)
NAMES = (
    "Thoa", "Lẫm", "Quế Sa", "Vĩnh Rô", "Nậm Diễn", "Hòn Tạo", "Cẩm Uyển", "Bàu Phao", "Khe Miên", "Thạch Trạch", "Mạc Hoài", "Lữ", "Kiều Trầm",
    "Ô Gạo", "Giang Bái", "Suối Lăng", "Đèo Vọng", "Yên Cát", "Tịnh Kiệu", "Hà", "Minh", "Lan", "Bình", "Ngọc", "Sung", "Đồng Cừ", "Lũng Ngạn", "Phú Thiềng",
)
